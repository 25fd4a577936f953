"""sparkvane.operators"""
