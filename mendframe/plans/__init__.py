"""Query registry: every operator bound to the driver tables, with its SQL twin."""
