"""Training-data operators: ten independent modules, their queries in :mod:`tidemill.llm.queries`."""
