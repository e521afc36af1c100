"""DataFrame operators: encoding, card history, as-of features, bags, alerts and models."""
