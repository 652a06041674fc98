"""See the README for what this folder holds."""
