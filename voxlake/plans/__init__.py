"""Plans of several operators: preprocessing pipelines, three-axis features, experiments."""
