"""wavemill.functions"""
