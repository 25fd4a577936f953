"""sparkvane.streaming"""
