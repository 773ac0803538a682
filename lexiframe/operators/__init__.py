"""lexiframe.operators"""
