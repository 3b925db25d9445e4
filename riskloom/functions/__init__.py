"""riskloom.functions"""
