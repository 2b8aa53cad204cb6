"""spanloom: near-duplicate sequence search over tokenized corpora, on Spark.

A compact window (doc, l, c, r) under a hash function says that every span [i, j] with l <= i <= c <= j <= r has its least
hash at position c. Spans of a query and of a document that share the least token under m of k functions are estimated to have
Jaccard similarity m / k. Everything here is a DataFrame pipeline over the relation windows(h, token, doc_id, l, c, r).
"""
