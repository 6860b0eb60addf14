"""Training-data operators: dedup, secrets, mixing, decontamination, chat, WARC, HTML, search, classifiers."""
