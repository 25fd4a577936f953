"""sparkvane.sources"""
