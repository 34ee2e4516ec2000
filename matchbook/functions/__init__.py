"""matchbook.functions"""
