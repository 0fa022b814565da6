"""wavemill.streaming"""
