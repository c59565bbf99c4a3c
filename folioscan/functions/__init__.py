"""Part of folioscan."""
