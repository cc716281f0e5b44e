"""framelake: media-frame and array analytics expressed as Spark DataFrames."""
