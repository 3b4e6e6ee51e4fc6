"""larkspur.plans"""
