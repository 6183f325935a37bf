"""Operators of a training-data pipeline over ``documents`` and ``pages``.

One module per operator; ``queries.py`` registers them.  Nothing else in the
package imports this subpackage.
"""
