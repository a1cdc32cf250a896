"""newsgauge.operators"""
