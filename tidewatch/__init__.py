"""Load-journal, data-quality, exchange and delivery analytics on Spark DataFrames.

Every operator takes DataFrames, parameters and an explicit ``as_of`` and returns a
DataFrame; nothing reads the clock and nothing pulls data-sized frames to the driver.
"""
