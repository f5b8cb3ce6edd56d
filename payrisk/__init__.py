"""Card-payment fraud analytics as Spark DataFrame jobs.

Sub-packages
    sources    files and tables in and out
    functions  column expressions
    operators  reusable distributed steps (history, quantiles, running totals)
    plans      the data products, reports, data sets, models and metrics
"""
