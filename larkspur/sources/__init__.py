"""larkspur.sources"""
