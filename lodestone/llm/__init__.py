"""Training-data operators: tokens, mixing, media, URL and text classifiers, near duplicates, HTML."""
