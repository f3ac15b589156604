"""Graph, feature, detection and scoring operators over transactions and their legs."""
