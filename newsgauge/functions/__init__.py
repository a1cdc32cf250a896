"""newsgauge.functions"""
