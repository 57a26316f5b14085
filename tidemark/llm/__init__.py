"""Training-data operators: filters, classifiers, fingerprints, mixing, packing and sharding of document tables.

Nothing outside this subpackage imports it.
"""
