"""palimpsest: governed, versioned records as Spark DataFrames.

Every operator takes and returns DataFrames; nothing collects rows on the driver.
"""
