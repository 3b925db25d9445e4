"""riskloom.plans"""
