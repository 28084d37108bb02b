"""DataFrame -> DataFrame operators (clinical marts, series, regression)."""
