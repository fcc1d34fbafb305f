"""Part of plumbline: operators."""
