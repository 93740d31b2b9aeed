"""wayfield.streaming"""
