"""larkspur.streaming"""
