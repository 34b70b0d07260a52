"""Views of other schemas as clinical tables."""
