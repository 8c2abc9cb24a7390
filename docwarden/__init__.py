"""Spark-native document retrieval and access analytics.

``functions``  column expressions (text, vectors, validation)
``sources``    file readers, derived test tables, snapshot sinks
``operators``  DataFrame-to-DataFrame operators
``plans``      the registered queries and their SQL oracles
``streaming``  micro-batch form of the upload pipeline
"""
