"""wavemill.operators"""
