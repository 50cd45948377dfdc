"""Analysis entry points: compositions of the operators.

Each returns lazily built tables by name; the caller picks the sink.
"""
