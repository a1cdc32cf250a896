"""newsgauge.sources"""
