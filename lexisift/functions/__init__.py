"""Part of lexisift; see the README."""
