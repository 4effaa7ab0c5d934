"""Job plans (training set, preference set, inference) and the check registry."""
