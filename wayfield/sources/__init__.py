"""wayfield.sources"""
