"""DataFrame operators: panel, transforms, indicators, scoring, serving."""
