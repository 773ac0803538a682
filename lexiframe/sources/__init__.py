"""lexiframe.sources"""
