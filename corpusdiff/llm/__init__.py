"""Operations of a training-data pipeline, each in a module of its own; the rest of the package does not use them."""
