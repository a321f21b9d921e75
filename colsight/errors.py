class DatasetError(ValueError):
    """The input table or the request does not fit the operator."""
