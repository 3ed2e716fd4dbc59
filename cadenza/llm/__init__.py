"""Operators for preparing training text at corpus scale; each module documents its rules."""
