"""skyloom: camera-frame time series on Spark.

Frames are rows ``rec_id, frame_idx, ut, height, width, px``; every operator is a
function from DataFrames to a DataFrame.
"""
