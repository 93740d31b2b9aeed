"""wayfield.operators"""
