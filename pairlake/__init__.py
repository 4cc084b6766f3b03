"""pairlake: build, judge and report on text-to-SQL datasets with Spark."""
