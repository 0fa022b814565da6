"""wavemill.sources"""
