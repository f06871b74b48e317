"""repotide: analytics over the metadata of many code repositories, as Spark jobs.

Every table carries ``repo_id``; every operator groups by it.
"""
