"""sparkvane.functions"""
