"""Marine track, slick and evidence analytics on Spark."""
