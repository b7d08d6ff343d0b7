"""Operators for training data: mixing, decontamination, personal data, near-duplicates, repeated
lines, chat formats, embeddings, licenses, toxicity and languages."""
