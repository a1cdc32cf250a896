"""newsgauge.plans"""
