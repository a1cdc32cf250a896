"""newsgauge.streaming"""
