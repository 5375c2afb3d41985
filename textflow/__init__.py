"""textflow: labelled-text cleaning, vocabulary, features, topics and
classifiers as composable Spark DataFrame operators.

Layout
------
``functions``  Column -> Column expressions (cleaning, arrays, vectors).
``operators``  DataFrame -> DataFrame operators (filters, vocabulary,
               sampling, features, topics, models, metrics).
``sources``    readers / writers and the mapping of the test tables.
``plans``      whole pipelines composed from the operators.
"""

__version__ = "0.1.0"
