"""Registered queries by subject, each with SQL over the same tables; ``larder.queries`` joins them."""
