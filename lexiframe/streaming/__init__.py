"""lexiframe.streaming"""
