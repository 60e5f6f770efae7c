"""Operators for preparing language-model training text, each a Spark job over ``documents``
or ``pages``; :mod:`.queries` registers one query per operator."""
