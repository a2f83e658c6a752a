"""DataFrame operators: detectors, reducers, roll-ups and rewriters."""
