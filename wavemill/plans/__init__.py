"""wavemill.plans"""
