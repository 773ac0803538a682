"""lexiframe.sinks"""
