"""Training-data operators: mixing, search, filters, classifiers, joins, packing and media columns."""
