"""Change-impact analytics as DataFrame transformations."""
