"""No streaming jobs: every workload of this library is a batch job over tables.

Resumable append logs are batch anti-joins, see ``ballast.sources.log.append_scored``.
"""
