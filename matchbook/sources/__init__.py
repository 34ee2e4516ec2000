"""matchbook.sources"""
