"""larkspur.operators"""
