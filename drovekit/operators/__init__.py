"""Operators that SQL alone can't express: matching, clustering, regression, sampling."""
