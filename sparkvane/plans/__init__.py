"""sparkvane.plans"""
