"""Analytics over multi-turn conversations, run tables and their traces, as PySpark DataFrame operators."""
