"""wayfield.functions"""
