"""DataFrame to DataFrame operators: profile, prepare, split, shift, synthesise, score, evaluate, compare."""
