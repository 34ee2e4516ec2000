"""matchbook.operators"""
