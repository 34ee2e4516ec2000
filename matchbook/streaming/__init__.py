"""matchbook.streaming"""
