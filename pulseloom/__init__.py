"""pulseloom: Spark jobs for preparing, labelling and evaluating large recording and text collections."""
