"""larkspur.queries"""
