"""wayfield.plans"""
