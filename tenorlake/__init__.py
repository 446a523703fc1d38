"""tenorlake: panel and curve analytics expressed as Spark DataFrame plans."""
