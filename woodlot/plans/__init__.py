"""Growth of trees and forests, boosting, and the fitted model."""
