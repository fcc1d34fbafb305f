"""Part of plumbline: plans."""
