"""Domain tables and the operations on them, for batches of requests.

A write takes the tables and a table of requests (at most one a record) and
returns the new tables and the outcomes: ``ok``, or the first rule that the
request breaks; a request that breaks a rule changes nothing.
"""
