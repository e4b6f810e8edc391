"""Training-data operators: WARC, chat, classifiers, BPE, sharding, joins, packing, rules."""
