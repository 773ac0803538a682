"""lexiframe.plans"""
